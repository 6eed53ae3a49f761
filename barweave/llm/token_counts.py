"""Token counts without token ids: pieces are counted once per distinct pre-token of the corpus and
summed over each document's pre-token frequencies."""

from __future__ import annotations

import functools
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .pretokens import answer_parts, finish_blocks, make_blocks, unpack, word_numbers

#: What the byte-level pre-tokenizer splits by.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.cache
def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > ``limit``) per row of ``docs``.

    ``path`` is a byte-level BPE file of the tokenizers library. A null text counts as empty (0 bytes, 0
    tokens, not over the limit); a null id is passed on; repeated rows give repeated results; an empty
    table gives an empty one; columns other than the two named are ignored. Added special strings inside a
    text count one token each, which is that library's default. Whole texts are counted, of any length.
    """
    tokenizer = load(path)
    special = sorted((t.content for t in tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
    docs = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    blocks = make_blocks(docs, BYTE_LEVEL, special, False, "token-counts")

    def solve(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        model = load(path)
        model.encode_special_tokens = True
        counts = np.empty(len(words), np.int64)
        for at in range(0, len(words), 20_000):
            some = [w.decode("utf-8", "surrogatepass") for w in words[at : at + 20_000]]
            counts[at : at + len(some)] = [len(e) for e in model.encode_batch_fast(some, add_special_tokens=False)]
        return np.full(len(words), 1, np.int64), counts

    def finish(row: dict, sizes: np.ndarray, values: np.ndarray) -> pa.Table:
        ids, freqs = word_numbers(row), np.frombuffer(unpack(row["freqs"]), "<u4").astype(np.int64)
        sums = np.concatenate([[0], np.cumsum(freqs * values[ids])]) if len(ids) else np.zeros(1, np.int64)
        ends = np.cumsum(row["sizes"])
        n = sums[ends] - sums[ends - row["sizes"]] + np.array(row["extra"])
        return pa.table({"doc_id": pa.array(row["doc_ids"], pa.int64()), "n_bytes": pa.array(row["n_bytes"], pa.int64()), "n_tokens": pa.array(n, pa.int64()), "over_limit": pa.array(n > limit)})

    answers = answer_parts(blocks, solve, "<u4")
    return finish_blocks(blocks, answers, finish, "doc_id long, n_bytes long, n_tokens long, over_limit boolean", "<u4")
