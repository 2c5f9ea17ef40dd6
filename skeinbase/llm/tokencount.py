"""Token counts under a unigram model, by dynamic programming that a trie's prefixes share."""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, lean

MARK = "▁"  # what the vocabulary puts for the space before a word
#: A byte that no piece has is a token of this much less probability than the least piece.
BYTE_PENALTY = 10.0


class Unigram:
    """Pieces with log-probabilities; characters that no piece has fall back on their bytes."""

    def __init__(self, pieces: dict[str, float]):
        self.pieces = pieces
        #: What pieces end with: beyond the first that isn't among them, no longer piece ends there.
        self.ends = {p[i:] for p in pieces for i in range(len(p))}
        self.byte = min(pieces.values(), default=0.0) - BYTE_PENALTY

    def counts(self, words: list[str]) -> list[tuple[float, int]]:
        """For each word of a sorted list the score of its likeliest segmentation and its tokens;
        of equally likely ones the fewest.

        Sorted words are their trie in preorder: the path to the word before is kept, and a word
        goes on from the prefix that both share, so that each node of the trie is scored once. A
        node has the forward score of its prefix; that of a word's last one is stored.
        """
        get, ends = self.pieces.get, self.ends
        path: list[tuple[float, int]] = [(0.0, 0)]  # by prefix length: forward score, minus tokens
        last, out = "", []
        for word in words:
            shared = 0
            for a, b in zip(word, last):
                if a != b:
                    break
                shared += 1
            del path[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                n = len(word[end - 1].encode())
                score, tokens = path[end - 1]
                best = (score + n * self.byte, tokens - n)
                for start in range(end - 1, -1, -1):
                    piece = word[start:end]
                    if piece not in ends:
                        break
                    p = get(piece)
                    if p is not None:
                        score, tokens = path[start]
                        if (found := (score + p, tokens - 1)) > best:
                            best = found
                path.append(best)
            last = word
            out.append((path[-1][0], -path[-1][1]))
        return out


def zipf_pieces(path: str) -> dict[str, float]:
    """Pieces of a sentencepiece model file in the order of their merges, with Zipf's law for their
    probabilities: the file has ranks and no probabilities. Control, byte and unknown pieces are
    left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    plain.sort(key=lambda i: (-model.get_score(i), i))
    total = log(sum(1 / (r + 1) for r in range(len(plain))))
    return {model.id_to_piece(i): -log(r + 1) - total for r, i in enumerate(plain)}


def count_tokens(docs: DataFrame, pieces: dict[str, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_tokens, score): tokens of each row's whole text, and their log-probability.

    Pre-tokens are what ASCII white space leaves, each with the vocabulary's mark before it. Those
    of a batch of texts are told apart, scored once in a trie, and summed by text. A null or empty
    text has none. One row for each row; no shuffle.
    """
    held = docs.sparkSession.sparkContext.broadcast(Unigram(pieces))  # a vocabulary: of a fixed size, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number: dict[bytes, int] = {}
            texts = []
            for t in batch.column(1):
                words = t.as_py().split()
                texts.append(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int32, len(words)))
            order = sorted((MARK + w.decode(), i) for w, i in number.items())
            score, tokens = np.zeros(len(number)), np.zeros(len(number), np.int64)
            for (_, i), (s, n) in zip(order, held.value.counts([w for w, _ in order])):
                score[i], tokens[i] = s, n
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([int(tokens[t].sum()) for t in texts], pa.int64()), pa.array([float(score[t].sum()) for t in texts], pa.float64())], ["id", "n_words", "n_tokens", "score"])

    own = docs.select(F.col(id_col).alias("id"), as_bytes(text_col).alias("text"))
    return own.mapInArrow(lean(run), f"id {own.dtypes[0][1]}, n_words long, n_tokens long, score double")
