"""Token counts of a unigram model, computed once per shared prefix of the words."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
# Words of which counts are remembered, and words taken at a time.
REMEMBERED = 400_000
TAKEN = 1 << 20


def load_pieces(path: str = MODEL) -> dict[str, float]:
    """Pieces of a public vocabulary with log probabilities.

    The vocabularies at hand are ranked but have no unigram probabilities, so a piece's
    is the harmonic one of its rank.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [
        model.id_to_piece(i) for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))
    ]
    whole = math.log(sum(1 / (i + 1) for i in range(len(names))))
    return {piece: -math.log(i + 1) - whole for i, piece in enumerate(names)}


class PrefixCounts:
    """Counts of the best segmentation for distinct words, walked as a trie.

    Words in sorted order are the trie in depth-first order: a word's path shares the
    nodes of the prefix it has in common with the word before. A node holds the best
    score of the text up to it and its number of pieces. Of equally good ways, that with
    fewer pieces counts. A character that no piece covers costs its UTF-8 bytes as pieces.
    """

    def __init__(self, pieces: dict[str, float]):
        self.pieces = pieces
        self.longest = max(map(len, pieces), default=1)
        self.byte = min(pieces.values(), default=0.0) - 10

    def count(self, words: list[str]) -> dict[str, int]:
        pieces, longest, byte = self.pieces.get, self.longest, self.byte
        path, scores, counts, done = "", [0.0], [0], {}
        for word in sorted(words):
            shared, most = 0, min(len(path), len(word))
            while shared < most and path[shared] == word[shared]:
                shared += 1
            del scores[shared + 1 :], counts[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                n = len(word[end - 1].encode())
                best, fewest = scores[end - 1] + byte * n, counts[end - 1] + n
                for start in range(max(0, end - longest), end):
                    p = pieces(word[start:end])
                    if p is not None:
                        s = scores[start] + p
                        if s > best or (s == best and counts[start] + 1 < fewest):
                            best, fewest = s, counts[start] + 1
                scores.append(best)
                counts.append(fewest)
            path, done[word] = word, counts[-1]
        return done


def count_tokens(docs: DataFrame, pieces: dict[str, float] | None = None) -> DataFrame:
    """doc_id, n_pretokens and n_tokens for every row of `docs`.

    A pre-token is a run without white space, with the mark of the space before it. Null
    and empty texts have none. A task takes the documents in blocks, finds the distinct
    pre-tokens that it doesn't remember, and counts them along their trie; nothing is
    shuffled. The vocabulary (some 32,000 pieces) is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load_pieces() if pieces is None else pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, known = PrefixCounts(shared.value), {}

        def counted(texts: list[list[str]]) -> Iterator[int]:
            new = {w for words in texts for w in words if w not in known}
            if len(known) + len(new) > REMEMBERED:
                known.clear()
                new = {w for words in texts for w in words}
            known.update(zip(new, map(trie.count([SPACE + w for w in new]).__getitem__, (SPACE + w for w in new)), strict=True))
            for words in texts:
                yield int(np.fromiter(map(known.__getitem__, words), np.int64, len(words)).sum())

        for batch in batches:
            totals, sizes, taken, n = [], [], [], 0
            for text in batch.column(1).to_pylist():
                words = (text or "").split()
                sizes.append(len(words))
                taken.append(words)
                n += len(words)
                if n >= TAKEN:
                    totals += counted(taken)
                    taken, n = [], 0
            totals += counted(taken)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(totals, pa.int64())],
                names=["doc_id", "n_pretokens", "n_tokens"],
            )

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, n_pretokens long, n_tokens long")
