"""Token counts under a unigram vocabulary by trie-shared dynamic programming.

A text is cut at white space into pre-tokens, each written with a leading word mark.  The distinct
pre-tokens go into a trie.  A node's forward score is the best unigram log-probability of the string
from the root to it, so that a prefix shared by many pre-tokens is scored once; a pre-token's count
is read off its terminal node.  The trie lives in the task: it needs no shuffle, and a task that is
lost is simply run again.

Ties between segmentations of equal score go to the one of fewer tokens.  A character that no piece
covers costs one token for each of its UTF-8 bytes (byte fallback).

Defined results: a null or empty text, or one of white space alone, has 0 tokens; repeated rows each
give a row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import gc
import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices

#: Default vocabulary: a SentencePiece file; any other path can be passed.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"


def unigram_vocabulary(path: str = VOCABULARY, scores: str = "zipf") -> dict[str, float]:
    """Pieces and their log-probabilities.

    ``scores="model"`` takes the file's scores (a unigram model).  ``"zipf"`` suits files that only
    rank their pieces, as merge-based vocabularies do: the piece of rank r gets log(1 / (r + 1)), normalised.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    if scores == "model":
        return {model.id_to_piece(i): model.get_score(i) for i in pieces}
    total = math.log(sum(1 / (r + 1) for r in range(len(pieces))))
    return {model.id_to_piece(i): -math.log(r + 1) - total for r, i in enumerate(pieces)}


class ForwardTrie:
    """Trie of pre-tokens whose nodes hold the best forward score, its token count, and the pieces still open there.

    A piece is open at a node if the string to the node ends with a proper prefix of it; the list holds the
    place reached in the vocabulary's own trie and the forward score at the piece's start.
    """

    def __init__(self, vocabulary: dict[str, float], max_nodes: int = 150_000, max_depth: int = 200) -> None:
        self.fallback = min(vocabulary.values(), default=0.0) - 10.0
        self.max_nodes, self.max_depth = max_nodes, max_depth
        self.pieces: dict = {}
        for piece, score in vocabulary.items():
            at = self.pieces
            for char in piece:
                at = at.setdefault(char, {})
            at[""] = score
        self.clear()

    def clear(self) -> None:
        self.size = 1
        self.root = (0.0, 0, [], {})

    def step(self, char: str, score: float, tokens: int, open_: list) -> tuple[float, int, list, dict]:
        """The node below one with this score, token count and open pieces."""
        best, fewest, still = -math.inf, 0, []
        place = self.pieces.get(char)
        if place is not None:
            if (p := place.get("")) is not None:
                best, fewest = score + p, tokens + 1
            if len(place) > 1:
                still.append((place, score, tokens))
        if best == -math.inf:
            n = len(char.encode("utf-8", "surrogatepass"))
            best, fewest = score + n * self.fallback, tokens + n
        for place, start, count in open_:
            if (place := place.get(char)) is not None:
                if (p := place.get("")) is not None:
                    if (total := start + p) > best or total == best and count + 1 < fewest:
                        best, fewest = total, count + 1
                    if len(place) == 1:
                        continue
                still.append((place, start, count))
        return best, fewest, still, {}

    def count(self, pretoken: str) -> int:
        """Tokens of one pre-token; prefixes already in the trie are not scored again."""
        node, keep = self.root, len(pretoken) <= self.max_depth
        for char in pretoken:
            child = node[3].get(char)
            if child is None:
                child = self.step(char, node[0], node[1], node[2])
                if keep:  # a longer one is too rare to share: the same recurrence without nodes
                    node[3][char] = child
                    self.size += 1
            node = child
        return node[1]


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: dict[str, float] | None = None, max_nodes: int = 150_000, max_words: int = 200_000) -> DataFrame:
    """One row per document: id, n_tokens and n_pretokens (longs).

    ``max_nodes`` and ``max_words`` bound a task's trie and its table of terminal counts; beyond them
    they are begun anew, which costs time but changes no count.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(unigram_vocabulary() if vocabulary is None else vocabulary)
    kind = docs.schema[id_col].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # nodes are many and never form a cycle
        trie, terminal = ForwardTrie(shared.value, max_nodes), {}
        for part, texts in (x for batch in batches for x in text_slices(batch)):
            tokens, pretokens = [], []
            for text in texts:
                words = Counter((text or "").split())
                if new := sorted(w for w in words if w not in terminal):
                    if len(terminal) + len(new) > max_words:
                        terminal.clear()
                        new = sorted(words)
                    if trie.size > max_nodes:
                        trie.clear()
                    for w in new:
                        terminal[w] = trie.count(MARK + w)
                tokens.append(sum(terminal[w] * n for w, n in words.items()))
                pretokens.append(sum(words.values()))
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(tokens, pa.int64()), pa.array(pretokens, pa.int64())], ["id", "n_tokens", "n_pretokens"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(count, f"id {kind}, n_tokens long, n_pretokens long").withColumnRenamed("id", id_col)
