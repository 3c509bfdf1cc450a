"""Token counts without tokens: count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton enumerates the vocabulary pieces that end at each character; dynamic
programming carries the best score and its number of pieces. The rules are those of a unigram
tokenizer with a metaspace splitter and byte fallback:

* a space becomes U+2581, one stands before the text, and each starts a new word;
* pieces are tried by their start, and only a better score replaces one that was found before,
  so of equal paths the one whose last piece starts first wins;
* a character that is no piece costs 10 below the lowest score, and counts one token a byte of
  UTF-8 where the vocabulary has the byte pieces, else one token for a run of such characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices

SPACE = "▁"
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


def load_pieces(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), float(model.get_score(i))) for i in range(model.get_piece_size())]


class Counter:
    """Counts the tokens of texts; remembers at most ``keep`` words."""

    def __init__(self, pieces: list[tuple[str, float]], keep: int = 1 << 19):
        self.machine = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.machine.add_word(piece, (len(piece), score))
        self.machine.make_automaton()
        known = {p for p, _ in pieces}
        self.single = {p for p in known if len(p) == 1}
        self.unknown = min((s for _, s in pieces), default=0.0) - 10.0
        self.bytes = all(f"<0x{b:02X}>" in known for b in range(256))
        self.words: dict[str, tuple[int, float]] = {}
        self.keep = keep

    def word(self, word: str) -> tuple[int, float]:
        """Number of pieces and score of the best path through one word, which starts with U+2581."""
        n = len(word)
        best: list[float] = [0.0] * (n + 1)
        count = [0] * (n + 1)
        lost = [False] * (n + 1)  # the best path ends in an unknown character
        done = 0  # positions up to here are final

        def unknown(at: int, found: bool) -> None:
            if word[at - 1] in self.single:
                return
            score = best[at - 1] + self.unknown
            if not found or score > best[at]:
                more = len(word[at - 1].encode("utf-8", "surrogatepass")) if self.bytes else int(not lost[at - 1])
                best[at], count[at], lost[at] = score, count[at - 1] + more, True

        found = False
        for end, (length, score) in self.machine.iter(word):
            while done < end:
                unknown(done + 1, found)
                done, found = done + 1, False
            score += best[end + 1 - length]
            if not found or score > best[end + 1]:
                best[end + 1], count[end + 1], lost[end + 1], found = score, count[end + 1 - length] + 1, False, True
        while done < n:
            unknown(done + 1, found)
            done, found = done + 1, False
        return count[n], best[n]

    def text(self, text: str) -> tuple[int, float]:
        """Number of tokens and score of a text; an empty text has none."""
        if not text:
            return 0, 0.0
        words, total, score = self.words, 0, 0.0
        text = text.replace(SPACE, " ")
        for word in (text[1:] if text[0] == " " else text).split(" "):
            found = words.get(word)
            if found is None:
                found = self.word(SPACE + word)
                if len(word) < 64:
                    if len(words) >= self.keep:
                        words.clear()
                    words[word] = found
            total += found[0]
            score += found[1]
        return total, score


def count_tokens(spark: SparkSession, docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, score`` for each row, over its whole text.

    ``vocabulary`` is read by the driver only; its pieces are broadcast, and a vocabulary's size
    doesn't follow the input. A null or empty text has 0 tokens and score 0. Repeated rows stay
    repeated; an empty table gives an empty result.
    """
    pieces = spark.sparkContext.broadcast(load_pieces(vocabulary))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(pieces.value)
        for batch in slices(batches):
            found = [counter.text(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array([s for _, s in found], pa.float64())], names=["doc_id", "n_tokens", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(count, "doc_id long, n_tokens long, score double")
