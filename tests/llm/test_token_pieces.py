"""The cut into pieces gives the library's ids for every text, however little is remembered."""

import random

import numpy as np
import pyarrow as pa
import pytest

from cuelake.llm import textkernel as tk
from cuelake.llm import token_file

PARTS = [" ", "  ", "\n", "\n\n", "\t", "a", "bc", "word", "'s", "'t", "''", "'ll", "don't", "1", "23", "é", "ß", "́", " ", "\xa0", "　", "日本", "😀", ".", ",", "!!!", "_", "#"]
PARTS += ["<|endoftext|>", "\x1c", "\x00", "\x85", "A1b2", "İ", "ſ", "​", "²", "ⅷ", "\r\n", "x\ny"]


@pytest.mark.parametrize("memory", [40, 100_000])
def test_pieces_give_the_library_s_ids(memory):
    r = random.Random(memory)
    texts = ["".join(r.choice(PARTS) for _ in range(r.randrange(0, 14))) for _ in range(8_000)]
    enc = token_file.Encoder(token_file.tokenizer_path(), memory)
    want = [e.ids for e in enc.tok.encode_batch(texts, add_special_tokens=False)]
    for first, end, data, offsets in tk.text_slices(pa.array(texts), 4_000):
        ids, n = enc.encode(data, offsets)
        for i, own in enumerate(np.split(ids, np.cumsum(n)[:-1])):
            assert own.tolist() == want[first + i], texts[first + i]


def test_blocks_of_many_widths_and_sizes(spark, monkeypatch):
    """Blocks end after the document that fills them; ids of four bytes come back too."""
    monkeypatch.setattr(token_file, "BLOCK_TOKENS", 50)
    rows = [(i, "é word " * (i % 40)) for i in range(120)]
    blocks, lengths = token_file.write_token_file(spark.createDataFrame(rows, "doc_id long, text string"))
    got = token_file.read_token_file(blocks, lengths).orderBy("doc_id").collect()
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(token_file.tokenizer_path())
    assert [np.frombuffer(x.ids, "<u4").tolist() for x in got] == [tok.encode(t).ids + [0] for _, t in rows]
    wide = np.array([70_000, 5, 6], "<u4")
    column = pa.array([wide.tobytes(), np.array([1, 2], "<u2").tobytes(), b""], pa.binary())
    assert token_file._batch_ids(column, np.array([3, 2, 0])).tolist() == [70_000, 5, 6, 1, 2]
