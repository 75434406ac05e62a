"""Token counts by unigram segmentation, with forward scores shared between pre-tokens.

The distinct pre-tokens of a batch are walked in order as a trie, depth first: the best score and
token count of a prefix is computed once, whichever pre-tokens go on from it, and the count at the end
of a pre-token is kept for all its later occurrences.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log
from os.path import commonprefix

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from elastrain.llm.common import arrow_map, column, documents, grouped

BLANK = "▁"
CACHE_SIZE = 400_000
#: How much rarer a byte of an unknown character is than the last piece of the vocabulary.
BYTE_PENALTY = 10.0

Vocabulary = dict[str, float | None]


def load_pieces(path: str) -> list[str]:
    """The ordinary pieces of a model file, most frequent first; control, byte and unused pieces are left out."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    ids = [i for i in ids if model.get_score(i) > -1e8]
    return [model.id_to_piece(i) for i in sorted(ids, key=model.get_score, reverse=True)]


def unigram(pieces: list[str]) -> tuple[Vocabulary, float]:
    """Log probabilities by Zipf's rule from the rank, for every piece and (None) every proper end of one; that of a byte."""
    total = log(sum(1 / (r + 1) for r in range(len(pieces))))
    known: Vocabulary = {p[i:]: None for p in pieces for i in range(1, len(p))}
    known.update({p: -log(r + 1) - total for r, p in enumerate(pieces)})
    return known, -log(len(pieces) + 1) - total - BYTE_PENALTY


def count_all(words: Iterator[str], known: Vocabulary, byte: float) -> Iterator[tuple[str, int]]:
    """(word, tokens of its best segmentation) for words in ascending order.

    The best has the highest score, then the fewest tokens. A character that no piece covers may stand
    as the bytes of its UTF-8, one token each.
    """
    scores, counts, last = [0.0], [0], ""
    for word in words:
        common = len(commonprefix((word, last)))
        del scores[common + 1 :], counts[common + 1 :]
        for end in range(common + 1, len(word) + 1):
            size = len(word[end - 1].encode())
            best, fewest = scores[end - 1] + size * byte, counts[end - 1] + size
            for start in range(end - 1, -1, -1):
                tail = word[start:end]
                if tail not in known:
                    break
                if (own := known[tail]) is not None:
                    score, count = scores[start] + own, counts[start] + 1
                    if score > best or (score == best and count < fewest):
                        best, fewest = score, count
            scores.append(best)
            counts.append(fewest)
        last = word
        yield word, counts[-1]


def pre_tokens(text: str) -> list[str]:
    """A blank is put in front; every blank then starts a pre-token, which runs to the next one."""
    return [BLANK + w for w in text.split(" ")] if text else []


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_tokens, n_pretokens.

    Null and empty texts have none. Rows that repeat are each returned; an empty table gives no rows. The
    driver reads the model file; the vocabulary, of fixed size, is sent along.
    """
    sent = docs.sparkSession.sparkContext.broadcast(unigram(load_pieces(model_path)))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, byte = sent.value
        counts: dict[str, int] = {}
        for batch in parts:
            tokens, sizes = [], []
            for group in grouped(column(batch, "text")):
                split = [pre_tokens(t) for t in group]
                new = {w for words in split for w in words if w not in counts}
                if len(counts) + len(new) > CACHE_SIZE:
                    counts.clear()
                    new = {w for words in split for w in words}
                counts.update(count_all(sorted(new), known, byte))
                tokens += [sum(map(counts.__getitem__, words)) for words in split]
                sizes += map(len, split)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens, pa.int64()), pa.array(sizes, pa.int64())], names=["doc_id", "n_tokens", "n_pretokens"])

    return arrow_map(documents(docs, id_col, text_col), run, "doc_id bigint, n_tokens bigint, n_pretokens bigint")
