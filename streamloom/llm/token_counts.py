"""Token counts by a count-only Viterbi search over a unigram vocabulary.

An Aho-Corasick automaton lists the vocabulary pieces that end at each place;
dynamic programming carries the best score and its number of pieces, never the
path.  Ties go to the candidate that starts first, as in the tokenizers'
search, which replaces a candidate only by a strictly better one.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from streamloom.llm.common import id_text, map_arrow, slices

#: Words that a task remembers before it starts anew.
CACHE_UNITS = 200_000
#: Fixed value: an unknown character scores this much less than the least piece.
UNKNOWN_PENALTY = 10.0
SPACE = "▁"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Counter:
    """The pieces and scores of a sentencepiece file, searched as a unigram model."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.auto = ahocorasick.Automaton()
        self.bytes = False
        least, chars = 0.0, set()
        joins_space = False
        for i in range(sp.get_piece_size()):
            if sp.is_byte(i):
                self.bytes = True
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                piece, score = sp.id_to_piece(i), sp.get_score(i)
                self.auto.add_word(piece, (len(piece), score))
                least = min(least, score)
                if len(piece) == 1:
                    chars.add(piece)
                joins_space |= bool(re.search(f"[^{SPACE}]{SPACE}|.\n|\n.", piece))
        self.auto.make_automaton()
        self.chars, self.unknown = chars, least - UNKNOWN_PENALTY
        # No piece crosses from a word into the next one's space mark, so each word has its own best path.
        self.units = None if joins_space else re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
        self.cache: dict[str, tuple[int, float]] = {}

    def search(self, unit: str) -> tuple[int, float]:
        """Number of tokens and score of the best path through ``unit``."""
        n = len(unit)
        best: list[float | None] = [None] * (n + 1)
        count = [0] * (n + 1)
        best[0] = 0.0
        done, chars = 0, self.chars

        def settle(upto: int) -> None:
            """Ends that have all their matches: an unknown character is their last candidate."""
            nonlocal done
            while done < upto:
                if unit[done] not in chars:
                    s = best[done] + self.unknown
                    old = best[done + 1]
                    if old is None or s > old:
                        best[done + 1] = s
                        fused = done and unit[done - 1] not in chars
                        count[done + 1] = count[done] + (len(unit[done].encode()) if self.bytes else 0 if fused else 1)
                done += 1

        for last, (size, score) in self.auto.iter(unit):
            if last > done:
                settle(last)
            start = last + 1 - size
            s = best[start] + score
            old = best[last + 1]
            if old is None or s > old:
                best[last + 1] = s
                count[last + 1] = count[start] + 1
        settle(n)
        return count[n], best[n]

    def count(self, text: str) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        text = SPACE + text.replace(" ", SPACE)
        if self.units is None:
            return self.search(text)
        cache = self.cache
        units = self.units.findall(text)
        if len(cache) > CACHE_UNITS:
            cache.clear()
        for u in set(units).difference(cache):
            cache[u] = self.search(u)
        found = list(map(cache.__getitem__, units))
        return sum(x[0] for x in found), sum(x[1] for x in found)


def counter(path: str) -> Counter:
    kept = sys.modules[__name__].__dict__.setdefault("_counters", {})
    if path not in kept:
        kept[path] = Counter(path)
    return kept[path]


def count_tokens(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, score of every whole text; null and empty text count 0.

    A space mark precedes each text.  Characters that no piece has cost one
    token for each of their UTF-8 bytes.  Repeated rows give repeated rows.
    """
    path = path or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for b in slices(batches):
            out = [c.count(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.float64())], names=["doc_id", "n_tokens", "score"])
        c.cache.clear()

    return map_arrow(id_text(docs, id_col, text_col), run, "doc_id long, n_tokens long, score double")
