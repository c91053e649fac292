"""BPE encoding and decoding with a contiguous rank array.

A short word is held as its parts (token ids) next to the ranks of the adjacent pairs. The array is
scanned for the smallest rank, the boundary there is deleted, and the ranks of the two neighbours
are refreshed, until no pair has a rank. Words of equal length share one such array, a row each, so
that numpy does the scanning for all of them at once. A very long word, for which scanning again
and again would be quadratic, keeps its pairs in a heap instead; the merges are the same.

The vocabulary file is a parameter: a tokenizers JSON of kind BPE with byte-level characters, an
optional end-of-word suffix and the normaliser and pattern that its reader below names.

Which characters are letters, numbers or white space, and what they are in lower case, differs between
versions of Unicode. The library's own answers for every code point are taken once, on the driver, and
go to the workers as ranges. A text with a character that this Python normalises otherwise, or doesn't know,
is normalised by the library.

Defined results: a null text encodes as the empty text: no tokens, and the decoded text is empty.
Special tokens that occur in a text become their id, as the library does by default. Repeated rows
are encoded alike; other columns are kept out of the result unless named. Texts of any length are encoded
whole. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
import sys
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assurelake.llm.common import batches, small_batches, table

#: Words up to this many bytes go through the shared rank array.
SHORT = 64
#: Words whose ids are remembered between batches, at most.
REMEMBERED = 150_000
#: Texts are encoded together up to about this many characters.
TOGETHER = 2_000_000
#: Marks that often end a word and are no letters.
STOPS = ".,;:!?)"
NO_RANK = np.int32(2**31 - 1)


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


@dataclass(frozen=True)
class Characters:
    """What a tokenizer takes for letters, numbers and white space, and the characters that it alone is to
    normalise: the insides of character classes."""

    letters: str
    numbers: str
    spaces: str
    own: str


def _is_latin(text: str) -> bool:
    """All characters are below 256: a copy tells that much faster than a search."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def _ranges(points: Iterable[int]) -> str:
    """Ascending code points as the inside of a character class."""
    out: list[list[int]] = []
    for c in points:
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(re.escape(chr(a)) if a == b else f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in out)


_characters: dict[tuple[str, float], Characters] = {}


def characters(path: str) -> Characters:
    """Asks the library about every code point, once for a file."""
    key = (path, os.path.getmtime(path))
    if key in _characters:
        return _characters[key]
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    cut, norm = library.pre_tokenizer.pre_tokenize_str, library.normalizer.normalize_str
    every = [c for c in range(sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF]
    kinds: dict[str, list[int]] = {"letter": [], "number": [], "sign": [], "space": []}
    own: set[int] = set()
    for start in range(0, len(every), 20_000):
        some = every[start : start + 20_000]
        # pieces of the code points in a row are of one kind each, and white space is in none
        pieces = [at for _, at in cut("".join(map(chr, some)))]
        # a letter joins an a before it, a sign a !, a number neither
        ends = dict(at for _, at in cut("".join(f"a{chr(some[a])} !{chr(some[a])} " for a, _ in pieces)))
        after = 0
        for n, (a, b) in enumerate(pieces):
            kind = "letter" if ends.get(6 * n) == 6 * n + 2 else "number" if ends.get(6 * n + 3) == 6 * n + 4 else "sign"
            kinds["space"] += some[after:a]
            kinds[kind] += some[a:b]
            after = b
        kinds["space"] += some[after:]
        # a letter that nothing composes with keeps them apart
        theirs = [t[1:] for t in norm("".join(f"\u2c65{chr(c)}\n" for c in some)).split(" ")[:-1]]
        own.update(c for c, t in zip(some, theirs, strict=True) if unicodedata.category(chr(c)) == "Cn" or Bpe.normalise(chr(c)) != t)
    for c in every:
        parts = unicodedata.decomposition(chr(c))
        if parts and parts[0] != "<" and not _alike(norm, "".join(chr(int(p, 16)) for p in parts.split())):
            own.update([c, *(int(p, 16) for p in parts.split())])
        # marks that are put in order: with one of each usual class before and after
        if unicodedata.combining(chr(c)) and not all(_alike(norm, f"\u2c65{x}{chr(c)}{x}") for x in _MARKS):
            own.add(c)
    _characters[key] = Characters(*map(_ranges, (kinds["letter"], kinds["number"], kinds["space"], sorted(own - set(kinds["space"])))))
    return _characters[key]


#: Combining marks of the classes 1, 7, 9, 202, 216, 220, 222, 228, 230, 232, 233, 234 and 240.
_MARKS = "\u0334\u093c\u094d\u0327\u031b\u0316\u059a\u302e\u0301\u0315\u035c\u035d\u0345"


def _alike(norm, text: str) -> bool:
    return norm(text) == Bpe.normalise(text)


class Bpe:
    """A byte-level BPE vocabulary with its pair ranks."""

    def __init__(self, path: str, known: Characters):
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = dict(model["vocab"])
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        suffix = model.get("end_of_word_suffix") or ""
        splits = [p for p in (spec["pre_tokenizer"] or {}).get("pretokenizers", []) if p["type"] == "Split"]
        if not suffix or len(splits) != 1 or spec["decoder"] is not None:
            raise ValueError("this reader handles word-final vocabularies with one split pattern and no decoder")
        pattern = splits[0]["pattern"]["Regex"].replace(r"\s", known.spaces).replace(r"\p{L}", known.letters).replace(r"\p{N}", known.numbers)
        self.pattern, self.letters, self.spaces, self.own = re.compile(pattern), re.compile(f"[{known.letters}]+"), re.compile(f"[{known.spaces}]+"), re.compile(f"[{known.own}]")
        self.library, self.latin = None, not self.own.search("".join(map(chr, range(256))))
        self.special_pattern = re.compile("|".join(map(re.escape, self.specials))) if self.specials else None
        chars = byte_characters()
        self.byte_id = np.array([self.vocab[c] for c in chars], dtype=np.int32)
        self.last_id = np.array([self.vocab[c + suffix] for c in chars], dtype=np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([self.vocab[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([self.vocab[b] for _, b in pairs], dtype=np.int64)
        merged = np.array([self.vocab[a + b] for a, b in pairs], dtype=np.int32)
        keys = left << 20 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank_of, self.merged = keys[order], order.astype(np.int32), merged
        # ranks of pairs of single bytes, by the id of the left one and the place of the right one
        singles = np.concatenate([self.byte_id, self.last_id])
        self.place = np.zeros(singles.max() + 1, dtype=np.int32)
        self.place[singles] = np.arange(len(singles))
        self.first = np.full((len(self.place), len(singles)), NO_RANK, dtype=np.int32)
        for n, i in enumerate(singles.tolist()):
            self.first[singles, n] = self.ranks(singles, np.full(len(singles), i))
        size = max([*self.vocab.values(), *self.specials.values()]) + 1
        self.token = [""] * size
        for t, i in (self.vocab | self.specials).items():
            self.token[i] = t
        self.known: dict[str, bytes] = {}

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 20 | b
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.rank_of[at], NO_RANK)

    def merge_rows(self, parts: np.ndarray) -> list[bytes]:
        """Ids of words of one length: a row of `parts` for each word."""
        out: list[bytes] = [b""] * len(parts)
        row = np.arange(len(parts))
        ranks = self.first[parts[:, :-1], self.place[parts[:, 1:]]]
        while len(row):
            width = ranks.shape[1]
            if width == 0:
                least = at = None
                done = np.ones(len(row), dtype=bool)
            else:
                at = ranks.argmin(axis=1)
                least = ranks[np.arange(len(row)), at]
                done = least == NO_RANK
            if done.any():
                flat, w = np.ascontiguousarray(parts[done], dtype="<u4").tobytes(), 4 * parts.shape[1]
                for k, r in enumerate(row[done].tolist()):
                    out[r] = flat[k * w : k * w + w]
                if done.all():
                    break
                keep = ~done
                parts, ranks, row, at, least = parts[keep], ranks[keep], row[keep], at[keep], least[keep]
            n = np.arange(len(row))
            parts[n, at] = self.merged[least]
            # delete the boundary after the merged part: its part and its rank go, the rest move up
            col = np.arange(parts.shape[1] - 1)
            parts = np.where(col[None, :] > at[:, None], parts[:, 1:], parts[:, :-1])
            col = col[:-1]
            ranks = np.where(col[None, :] >= at[:, None], ranks[:, 1:], ranks[:, :-1])
            if ranks.shape[1]:
                has = at > 0
                ranks[n[has], at[has] - 1] = self.ranks(parts[n[has], at[has] - 1], parts[n[has], at[has]])
                has = at < ranks.shape[1]
                ranks[n[has], at[has]] = self.ranks(parts[n[has], at[has]], parts[n[has], at[has] + 1])
        return out

    def merge_long(self, ids: list[int]) -> bytes:
        """The same merges for one long word, smallest rank first, leftmost among equals, from a heap."""
        n = len(ids)
        nxt, prv, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        arr = np.array(ids, dtype=np.int64)
        heap = [(int(r), i, int(arr[i]), int(arr[i + 1])) for i, r in enumerate(self.ranks(arr[:-1], arr[1:])) if r != NO_RANK]
        heapq.heapify(heap)
        lookup = self.rank_table()
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if not alive[i] or j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i] = int(self.merged[r])
            alive[j] = False
            nxt[i] = nxt[j]
            if nxt[j] < n:
                prv[nxt[j]] = i
            for left in (prv[i], i):
                right = nxt[left] if left >= 0 else n
                if left >= 0 and right < n and (r2 := lookup.get((ids[left], ids[right]))) is not None:
                    heapq.heappush(heap, (r2, left, ids[left], ids[right]))
        return np.array([x for x, ok in zip(ids, alive, strict=True) if ok], dtype="<u4").tobytes()

    def rank_table(self) -> dict[tuple[int, int], int]:
        if not hasattr(self, "_rank_table"):
            pairs = zip((self.keys >> 20).tolist(), (self.keys & 0xFFFFF).tolist(), strict=True)
            self._rank_table = dict(zip(pairs, self.rank_of.tolist(), strict=True))
        return self._rank_table

    def words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word (UTF-8), as little-endian 32-bit integers."""
        out: list[bytes] = [b""] * len(words)
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        for n in np.unique(lengths).tolist():
            at = np.flatnonzero(lengths == n)
            if n > SHORT:
                for i in at.tolist():
                    raw = np.frombuffer(words[i], dtype=np.uint8)
                    out[i] = self.merge_long([*self.byte_id[raw[:-1]].tolist(), int(self.last_id[raw[-1]])])
                continue
            for some in np.array_split(at, len(at) // 20_000 + 1):
                raw = np.frombuffer(b"".join([words[i] for i in some.tolist()]), dtype=np.uint8).reshape(len(some), n)
                parts = np.empty(raw.shape, dtype=np.int32)
                parts[:, :-1], parts[:, -1] = self.byte_id[raw[:, :-1]], self.last_id[raw[:, -1]]
                for i, ids in zip(some.tolist(), self.merge_rows(parts), strict=True):
                    out[i] = ids
        return out

    @staticmethod
    def normalise(text: str) -> str:
        if text.isascii():
            return text.lower()
        # character by character, so that no letter's form depends on its place in a word
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def normalised(self, text: str) -> str:
        if text.isascii() or (self.latin and _is_latin(text)) or not self.own.search(text):
            return self.normalise(text)
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path).normalizer
        return self.library.normalize_str(text)

    def pieces(self, text: str) -> list[str]:
        """The normalised text cut at white space (what is between two cuts is encoded on its own)."""
        text = self.normalised(text)
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # Python takes these for white space, the pattern doesn't
            return [p for p in self.spaces.split(text) if p]
        return text.split()

    def is_word(self, piece: str) -> bool:
        """One run of letters."""
        return piece.isalpha() if piece.isascii() else self.letters.fullmatch(piece) is not None

    def learn(self, pieces: set[str]) -> None:
        """Remember the ids of pieces that aren't known yet."""
        new = [p for p in pieces if p not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = list(pieces)
        if not new:
            return
        find, words, cut = self.pattern.findall, [], []
        for p in new:
            if self.is_word(p):
                words.append(p)
            elif p[-1] in STOPS and self.is_word(p[:-1]):
                words.append(p[:-1])
                cut.append((p, (p[:-1], p[-1])))
            else:
                ws = find(p)
                words += ws
                cut.append((p, ws))
        known = self.known
        distinct = [w for w in dict.fromkeys(words) if w not in known]
        distinct += [c for c in STOPS if c not in known]
        known.update(zip(distinct, self.words([w.encode("utf-8", "surrogatepass") for w in distinct]), strict=True))
        known.update([(p, b"".join([known[w] for w in ws])) for p, ws in cut])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of every text, as little-endian 32-bit integers."""
        runs: list[list[list[str] | bytes]] = []
        for t in texts:
            if self.special_pattern and self.special_pattern.search(t):
                parts, at = [], 0
                for m in self.special_pattern.finditer(t):
                    parts += [self.pieces(t[at : m.start()]), np.array([self.specials[m[0]]], dtype="<u4").tobytes()]
                    at = m.end()
                runs.append([*parts, self.pieces(t[at:])])
            else:
                runs.append([self.pieces(t)])
        seen: set[str] = set()
        for r in runs:
            for p in r:
                if isinstance(p, list):
                    seen.update(p)
        self.learn(seen)
        known = self.known
        return [b"".join([p if isinstance(p, bytes) else b"".join(map(known.__getitem__, p)) for p in r]) for r in runs]

    def decode(self, ids: bytes) -> str:
        """The text of ids: without a decoder the library joins the tokens with blanks."""
        return " ".join(map(self.token.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


_loaded: dict[tuple[str, float, Characters], Bpe] = {}


def load(path: str, known: Characters) -> Bpe:
    """The vocabulary at path, read once in each Python worker."""
    key = (path, os.path.getmtime(path), known)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Bpe(path, known)
    return _loaded[key]


def encode_decode(docs: DataFrame, vocabulary: str, key_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, with_text: bool = False) -> DataFrame:
    """Per row: the key, n_tokens, the SHA-256 of the ids and of the decoded text; on request the ids
    (array of int) and the decoded text themselves.

    `vocabulary` is a path that every worker can read.
    """
    small_batches(docs.sparkSession)
    known = characters(vocabulary)
    rows = docs.select(F.col(key_col), F.col(text_col).alias("_text"))
    key = rows.schema[0]
    fields = [pa.field("n_tokens", pa.int64()), pa.field("ids_sha256", pa.string()), pa.field("decoded_sha256", pa.string())]
    schema = f"`{key.name}` {key.dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if with_ids:
        fields.append(pa.field("ids", pa.list_(pa.int32())))
        schema += ", ids array<int>"
    if with_text:
        fields.append(pa.field("decoded", pa.string()))
        schema += ", decoded string"

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary, known)
        for frame in frames:
            for part in batches(frame, TOGETHER):
                ids = bpe.encode([t or "" for t in part.column(1).to_pylist()])
                sha, decoded, texts = [], [], []
                for x in ids:
                    text = bpe.decode(x)
                    sha.append(hashlib.sha256(x).hexdigest())
                    decoded.append(hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest())
                    if with_text:
                        texts.append(text)
                cols = [part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(sha), pa.array(decoded)]
                if with_ids:
                    cols.append(pa.array([np.frombuffer(x, dtype="<i4") for x in ids], pa.list_(pa.int32())))
                if with_text:
                    cols.append(pa.array(texts, pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names=[key.name, *(f.name for f in fields)])

    return rows.mapInArrow(run, schema)


def word_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded with the word-final vocabulary."""
    return encode_decode(table(spark, sf_dir, "documents"), word_vocabulary())
