"""Token counts under a unigram vocabulary without making tokens.

An Aho-Corasick automaton enumerates all vocabulary pieces that end at each character, and a Viterbi pass carries for
each position only the best score and the number of pieces. Rules are those of the tokenizers library's Unigram model:
scores are summed as doubles from the left; at one end position candidates are tried by ascending start and a later one
must be strictly better; a character that no one-character piece covers may also be read as unknown, at the lowest score
of the vocabulary less 10; with byte fallback an unknown stretch counts one piece for each UTF-8 byte if the vocabulary
has pieces for all its bytes, else a stretch of neighbouring unknown characters counts as one.

White space handling is the Metaspace rule: spaces become U+2581, one is put before the text unless it begins with one,
and the text is cut before each. Parts are independent, so each distinct part is solved once and remembered.

Null text counts as empty. Repeated rows are counted each; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtally.llm.common import kept_in_worker, map_rows

#: The mark for a space, and what an unknown character costs below the lowest score (fixed values).
SPACE_MARK, UNKNOWN_PENALTY = "▁", 10.0

#: Distinct parts whose result a task remembers.
REMEMBERED = 500_000
LONGEST_REMEMBERED = 64


def sentencepiece_vocabulary(path: str) -> tuple[list[tuple[str, float]], int]:
    """Pieces with scores in order of their ids, and the id of the unknown piece."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.vocab_size())], model.unk_id()


class UnigramCounter:
    def __init__(self, vocabulary: list[tuple[str, float]], byte_fallback: bool = True):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        pieces = {p for p, _ in vocabulary}
        self.bytes = {b for b in range(256) if f"<0x{b:02X}>" in pieces} if byte_fallback else set()
        self.unknown = min(s for _, s in vocabulary) - UNKNOWN_PENALTY
        self.known: dict[str, tuple[float, int, int]] = {}

    def solve(self, part: str) -> tuple[float, int, int]:
        """Best score, pieces, and characters read as unknown."""
        n = len(part)
        found: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, match in self.automaton.iter(part):
            found[end].append(match)
        score, count, unknown = [0.0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        stretch = [0] * (n + 1)  # where the unknown stretch that ends here began, plus one
        for end in range(1, n + 1):
            best, start, single = -math.inf, -1, False
            for size, s in sorted(found[end - 1], reverse=True):
                if score[end - size] + s > best:
                    best, start = score[end - size] + s, end - size
                single |= size == 1
            if not single and score[end - 1] + self.unknown > best:
                score[end], unknown[end] = score[end - 1] + self.unknown, unknown[end - 1] + 1
                stretch[end] = stretch[end - 1] or end
                begin = stretch[end] - 1
                data = part[begin:end].encode()
                count[end] = count[begin] + (len(data) if self.bytes.issuperset(data) else 1)
            else:
                score[end], count[end], unknown[end] = best, count[start] + 1, unknown[start]
        return score[n], count[n], unknown[n]

    def text(self, text: str) -> tuple[float, int, int, int]:
        """Score, pieces, unknown characters and parts of a whole text."""
        if not text:
            return 0.0, 0, 0, 0
        marked = text.replace(" ", SPACE_MARK)
        parts = Counter((marked if marked[0] == SPACE_MARK else SPACE_MARK + marked).split(SPACE_MARK)[1:])
        scores, pieces, unknown = [], 0, 0
        for part, times in parts.items():
            got = self.known.get(part)
            if got is None:
                got = self.solve(SPACE_MARK + part)
                if len(part) <= LONGEST_REMEMBERED and len(self.known) < REMEMBERED:
                    self.known[part] = got
            scores.append(got[0] * times)
            pieces += got[1] * times
            unknown += got[2] * times
        return math.fsum(scores), pieces, unknown, parts.total()


def counter(path: str) -> UnigramCounter:
    """The worker's own, with what it remembers from earlier tasks."""
    return kept_in_worker(("unigram", path), lambda: UnigramCounter(sentencepiece_vocabulary(path)[0]))


def count_tokens(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_parts, n_tokens, n_unknown (characters), score: counts over every whole text."""

    def make():
        solver = counter(model_path)

        def one(row):
            score, pieces, unknown, parts = solver.text(row[1] or "")
            return row[0], parts, pieces, unknown, score

        return one

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_rows(rows, "doc_id long, n_parts long, n_tokens long, n_unknown long, score double", make, keeps=True)
