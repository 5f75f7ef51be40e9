"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

The leaves of the tree are the merge ranks of neighbouring symbols; the root is
the leftmost lowest rank.  A merge updates three leaves in logarithmic time,
and the word is done when the root is infinite.  Many words of a similar length
share one two-dimensional tree, so each step is a few numpy operations; a very
long word has a flat tree of its own, whose updates end where nothing changes.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamloom.llm.common import id_text, map_arrow, slices

#: Words that a task remembers before it starts anew.
CACHE_WORDS = 200_000
#: Bytes of a word from which it has a tree of its own.
LONG_WORD = 2048
INF = np.int64(1) << 62


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_chars() -> list[str]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 stays, the rest follows from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


#: Characters (from-to, hexadecimal) that the tokenizers library takes for unassigned and the regex module
#: for letters or digits, below those after the last ideographs, which ABOVE adds.
NEWER = """
558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7
10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF3
16FF4-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24
1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F
2B81E 2CEA2-2CEAD
""".split()
ABOVE = "[" + "".join("-".join(chr(int(x, 16)) for x in span.split("-")) for span in NEWER) + "\U000323B0-\U0010FFFF]"

#: Capitals that the library lowers and that Python's tables may not know yet.
LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
LOWER |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}


class Encoder:
    """A tokenizer file of the kind: NFC, white space, lower case; split by pattern; byte-level BPE with word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        model, split = spec["model"], spec["pre_tokenizer"]["pretokenizers"][0]
        if kinds != ["NFC", "Replace", "Lowercase"] or split["type"] != "Split" or not split["invert"] or model["type"] != "BPE":
            raise ValueError(f"{path} is not a lower-case word-end BPE file")
        # White space here is the tokenizer's, which differs from Python's in the four separator controls.
        space = r"\t-\r\x20\x85\p{Z}"
        pattern = split["pattern"]["Regex"].replace(r"[^\s", "[^" + space)
        self.words = regex.compile(pattern)
        # Most texts have no character from the first of them on, which one comparison a character tells.
        above = ABOVE
        self.high, self.above = regex.compile(f"[{ABOVE[1]}-\U0010FFFF]"), regex.compile(above)
        self.capitals = regex.compile("[" + "".join(map(chr, LOWER)) + "]")
        self.words_above = regex.compile(pattern.replace(r"[\p{L}]+", rf"(?:(?!{above})\p{{L}})+").replace(r"[\p{N}]", rf"(?!{above})\p{{N}}").replace(rf"[^{space}\p{{L}}\p{{N}}]+", rf"(?:[^{space}\p{{L}}\p{{N}}]|{above})+"))
        vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        end, chars = model["end_of_word_suffix"], _byte_chars()
        self.names = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for k, v in (vocab | self.special).items():
            self.names[v] = k
        self.first = np.array([vocab.get(c, -1) for c in chars], np.int64)
        self.last = np.array([vocab.get(c + end, -1) for c in chars], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]
        self.pairs: dict[int, tuple[int, int]] | None = None
        self.ids: dict[str, bytes] = {}
        self.text: dict[str, bytes] = {}

    def _find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Places of the pairs in ``keys``, -1 for pairs that don't merge."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), at, -1)

    def _leaf(self, a: np.ndarray, b: np.ndarray, place: np.ndarray, width: int) -> np.ndarray:
        at = self._find(a, b)
        return np.where(at >= 0, self.ranks[at] * width + place, INF)

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of non-empty words of bytes."""
        out: list[np.ndarray] = [None] * len(words)  # type: ignore[list-item]
        groups: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            if len(w) >= LONG_WORD:
                out[i] = self._merge_long(w)
                continue
            groups.setdefault(max(2, 1 << (len(w) - 1).bit_length()), []).append(i)
        for width, members in groups.items():
            # Memory of a tree: few words at once when they are long.
            for at in range(0, len(members), step := max(1, (1 << 20) // width)):
                part = members[at : at + step]
                for i, ids in zip(part, self._merge([words[i] for i in part], width), strict=True):
                    out[i] = ids
        return out

    def _merge(self, words: list[bytes], width: int) -> list[np.ndarray]:
        n = len(words)
        sizes = np.array([len(w) for w in words])
        raw = np.zeros((n, width), np.uint8)
        inside = np.arange(width) < sizes[:, None]
        raw[inside] = np.frombuffer(b"".join(words), np.uint8)
        sym = self.first[raw]
        rows = np.arange(n)
        sym[rows, sizes - 1] = self.last[raw[rows, sizes - 1]]
        sym[~inside] = -1
        alive = inside & (sym >= 0)
        after = np.where(np.arange(1, width + 1) < sizes[:, None], np.arange(1, width + 1), width)
        before = np.tile(np.arange(-1, width - 1), (n, 1))
        tree = np.full((n, 2 * width), INF, np.int64)
        tree[:, width : 2 * width - 1] = self._leaf(sym[:, :-1], sym[:, 1:], np.arange(width - 1), width)
        size = width
        while size > 1:
            tree[:, size // 2 : size] = np.minimum(tree[:, size : 2 * size : 2], tree[:, size + 1 : 2 * size : 2])
            size //= 2
        sym, after, before, flat = sym.reshape(-1), after.reshape(-1), before.reshape(-1), tree.reshape(-1)
        gone = np.zeros(n * width, bool)

        def put(row: np.ndarray, place: np.ndarray, value: np.ndarray | np.int64) -> None:
            node, base = place + width, row * (2 * width)
            flat[base + node] = value
            for _ in range(width.bit_length() - 1):
                node = node >> 1
                flat[base + node] = np.minimum(flat[base + 2 * node], flat[base + 2 * node + 1])

        row = np.flatnonzero(flat[1 :: 2 * width] < INF)
        while len(row):
            left = flat[row * (2 * width) + 1] % width
            base = row * width
            right = after[base + left]
            new = self.made[self._find(sym[base + left], sym[base + right])]
            sym[base + left] = new
            gone[base + right] = True
            far = after[base + right]
            after[base + left] = far
            put(row, right, INF)
            put(row, left, INF)
            if (has := far < width).any():
                r, lf, fr = row[has], left[has], far[has]
                before[r * width + fr] = lf
                put(r, lf, self._leaf(new[has], sym[r * width + fr], lf, width))
            near = before[base + left]
            if (has := near >= 0).any():
                r, nr = row[has], near[has]
                put(r, nr, self._leaf(sym[r * width + nr], new[has], nr, width))
            row = row[flat[row * (2 * width) + 1] < INF]
        keep = alive & ~gone.reshape(n, width)
        ids, ends = sym.reshape(n, width)[keep], np.cumsum(keep.sum(axis=1))
        return np.split(ids, ends[:-1])

    def _merge_long(self, word: bytes) -> np.ndarray:
        """The ids of one long word."""
        n = len(word)
        width = 1 << (n - 1).bit_length()
        sym = self.first[np.frombuffer(word, np.uint8)]
        sym[n - 1] = self.last[word[n - 1]]
        if self.pairs is None:
            self.pairs = dict(zip(self.keys.tolist(), zip(self.ranks.tolist(), self.made.tolist(), strict=True), strict=True))
        leaves = np.full(width, INF, np.int64)
        leaves[: n - 1] = self._leaf(sym[:-1], sym[1:], np.arange(n - 1), width)
        levels = [leaves]
        while len(levels[-1]) > 1:
            levels.append(np.minimum(levels[-1][::2], levels[-1][1::2]))
        tree = array("q", np.concatenate([np.full(1, INF, np.int64), *levels[::-1]]).tobytes())
        ids, after, before = array("q", sym.tobytes()), array("q", range(1, n + 1)), array("q", range(-1, n - 1))
        infinite, pairs = int(INF), self.pairs

        def put(place: int, value: int) -> None:
            node = place + width
            tree[node] = value
            while node > 1:
                a, b = tree[node], tree[node ^ 1]
                least = a if a < b else b
                node >>= 1
                if tree[node] == least:
                    return
                tree[node] = least

        while tree[1] < infinite:
            left = tree[1] % width
            right = after[left]
            ids[left], ids[right] = pairs[ids[left] << 32 | ids[right]][1], -1
            far = after[left] = after[right]
            put(right, infinite)
            found = None
            if far < n:
                before[far] = left
                found = pairs.get(ids[left] << 32 | ids[far])
            put(left, infinite if found is None else found[0] * width + left)
            near = before[left]
            if near >= 0:
                found = pairs.get(ids[near] << 32 | ids[left]) if ids[near] >= 0 else None
                put(near, infinite if found is None else found[0] * width + near)
        found = np.frombuffer(ids, np.int64)
        return found[found >= 0].copy()

    def pieces(self, text: str) -> list[str]:
        """The words that are encoded one by one, and special tokens under their own names."""
        if self.specials is None or "<|" not in text:
            return self._pieces(text)
        out: list[str] = []
        for k, part in enumerate(self.specials.split(text)):
            out += [part] if k % 2 else self._pieces(part)
        return out

    def _pieces(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:  # the library lowers character by character
                text = text.replace("Σ", "σ")
            if self.high.search(text):
                if self.capitals.search(text):
                    text = text.translate(LOWER)
                if self.above.search(text):
                    return self.words_above.findall(text.lower())
        return self.words.findall(text.lower())

    def learn(self, words: set[str]) -> None:
        if len(self.ids) > CACHE_WORDS:
            self.forget()
        new = [w for w in words if w not in self.ids]
        plain = []
        for w in new:
            if w in self.special:
                self.ids[w], self.text[w] = self.special[w].to_bytes(4, "little"), (w + " ").encode()
            else:
                plain.append(w)
        for w, ids in zip(plain, self.merge([w.encode() for w in plain]), strict=True):
            self.ids[w] = ids.astype("<u4").tobytes()
            self.text[w] = "".join(self.names[i] + " " for i in ids).encode()

    def forget(self) -> None:
        self.ids.clear()
        self.text.clear()

    def encode(self, texts: list[str]) -> Iterator[tuple[bytes, bytes]]:
        """Ids as little-endian 32-bit integers, and the decoded text in UTF-8."""
        split = [self.pieces(t) for t in texts]
        self.learn(set().union(*split))
        for words in split:
            yield b"".join(map(self.ids.__getitem__, words)), b"".join(map(self.text.__getitem__, words))[:-1]


def encoder(path: str) -> Encoder:
    """One encoder for each vocabulary file and Python worker."""
    kept = sys.modules[__name__].__dict__.setdefault("_encoders", {})
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", decoded: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_le (binary) and decoded text of every whole text.

    ``path`` names the vocabulary file, which every executor must see.  Special
    tokens within texts are recognised.  Null and empty text: no ids and an
    empty decoded text.  Repeated rows give repeated rows.
    """
    path = path or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for b in slices(batches):
            ids, texts = zip(*coder.encode(b.column(1).to_pylist()), strict=True)
            cols = [b.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
            if decoded:
                cols.append(pa.array(texts, pa.binary()).cast(pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_tokens", "ids_le", "decoded"][: len(cols)])
        coder.forget()

    return map_arrow(id_text(docs, id_col, text_col), run, "doc_id long, n_tokens long, ids_le binary" + ", decoded string" * decoded)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and decoded text from ``ids_le``; unknown ids are an error, null ids give null."""
    path = path or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = encoder(path).names
        for b in slices(batches):
            texts = [None if x is None else " ".join(names[i] for i in np.frombuffer(x, "<u4")) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "decoded"])

    return map_arrow(encoded.select("doc_id", "ids_le"), run, "doc_id long, decoded string")


def digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Number and hash of the ids, and hash of the decoded text, of every row; null and empty text: 0 and the hashes of nothing."""
    rows = encode(docs, path)
    return rows.select("doc_id", "n_tokens", F.sha2("ids_le", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
