from __future__ import annotations

import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from loomwright.llm import encoder as encoding
from loomwright.llm import token_files as tf
from loomwright.llm.encoder import Encoder
from tests.llm.common import awkward, docs

TOKENIZER = "byte_bpe_50k.json"


def brute(rows, name=TOKENIZER, end=0):
    library = Tokenizer.from_file(public_tokenizers.path(name))
    return [[*library.encode(r[1] or "", add_special_tokens=False).ids, end] for r in rows]


@pytest.mark.parametrize("top", [1, 2, 200, 50_000, 2**32 - 1])
@pytest.mark.parametrize("n", [0, 1, 59, 60, 61, 4096, 4097, 20_000])
def test_ids_come_back(top, n):
    ids = np.random.default_rng(n).integers(0, top + 1, n).astype(np.uint64)
    words, starts = tf.pack(ids)
    assert (tf.unpack(words, n) == ids).all() and len(starts) == -(-n // tf.BLOCK)
    assert all((w >> 60) <= 13 for w in words.tolist())


def test_escapes_for_values_over_60_bits():
    ids = np.array([1, 2**61, 2**64 - 1, 2**63, 5, 0, 2**60 - 1, 2**60], dtype=np.uint64)
    words, _ = tf.pack(ids)
    assert (tf.unpack(words, len(ids)) == ids).all()


def test_one_block_decodes_alone():
    ids = np.random.default_rng(3).integers(0, 50_257, 3 * tf.BLOCK + 17)
    body = tf.write_file(np.array([len(ids)]), ids)
    for block in range(4):
        assert (tf.read_block(body, block) == ids[block * tf.BLOCK : (block + 1) * tf.BLOCK]).all()


AWKWARD = [
    *"ab.,#!?'9\u00e9\u00c9\u00df\u00ff\u0130\u03a3\u03c2\u0301\u00d7\u00f7\u1e9e\ufb01\u01c5\u4e2d\U0001f600\x00\x01\x1c\x7f", *" \n\t\r\x0b\x0c\x85\u00a0\u2003\u2028\u3000\u200b\ufeff",
    "  ", " \n", "\n\n", "'s", "'ll", ".,", ",.", "ing", "Tion", "12", "<|endoftext|>", "<|startoftext|>", "<|", "\u0130,",
]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_a_fresh_library(name):
    rng = random.Random(0)
    texts = ["".join(rng.choices(AWKWARD, k=rng.randrange(15))) for _ in range(8000)] + [r[1] or "" for r in awkward()]
    code = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    rng.shuffle(code)
    texts += ["a" + "".join(chr(c) + rng.choice(["", " ", ",", "b.", " x"]) for c in code[i : i + 40]) for i in range(0, len(code), 40)]  # all of Unicode
    library = Tokenizer.from_file(public_tokenizers.path(name))
    own = Encoder(name)
    for k in range(0, len(texts), 1000):
        part = texts[k : k + 1000]
        ids, bounds = own.encode([t.encode() for t in part], 7)
        want = [[*e.ids, 7] for e in library.encode_batch(part, add_special_tokens=False)]
        assert [ids[a:b].tolist() for a, b in itertools.pairwise(bounds.tolist())] == want


def test_encoder_forgets(monkeypatch):
    """A full table drops parts; ids stay right."""
    monkeypatch.setattr(encoding, "MOST_PARTS", 300)
    library, own, rng = Tokenizer.from_file(public_tokenizers.path(TOKENIZER)), Encoder(TOKENIZER), random.Random(1)
    for _ in range(30):
        text = " ".join(rng.choice(["the", "of", "word"]) + str(rng.randrange(400)) for _ in range(100))
        assert own.encode([text.encode()])[0].tolist() == library.encode(text, add_special_tokens=False).ids
        assert own.table.index.n < 600


def test_files_hold_every_document(spark):
    rows = awkward()
    found = tf.token_files(docs(spark, rows)).collect()
    ids = dict(zip([r[0] for r in rows], brute(rows), strict=True))
    order = sorted((r[0] if r[0] is not None else -1 for r in rows))
    start, want = 0, []
    for key in order:
        own = ids[key if key >= 0 else None]
        want.append((key, start, zlib.crc32(np.array(own, "<u4").tobytes())))
        start += len(own)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.start, zlib.crc32(r.ids)) for r in found) == sorted(want)


def test_no_documents(spark):
    assert tf.token_files(docs(spark, [])).count() == 0
