"""Token files and byte-level BPE against their public libraries, and the rank queue itself."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from parcelspark.llm import bpe_queue, token_files

RANKS, JSON = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def encoding():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe_queue.read_ranks(RANKS), special_tokens={})


def some_texts():
    draw = random.Random(5)
    parts = ["a", "'", "s", "'re", "'ll", " ", "  ", "\n", "\t", "12", "é", "日", "!", "--", "\xa0", "\x1c", "²", "th", "er", "😀", "=", "_", "<|endoftext|>", "\x85", " "]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 40))) for _ in range(1500)]
    return [*texts, "", "a" * 3000, "ab" * 2000, " " * 500, "th" * 3000, "0123456789" * 300, "\U0010ffff x \U0010ffff"]


def test_queue_gives_the_lowest_member():
    queue, draw, held = bpe_queue.RankQueue(60000), random.Random(1), set()
    for _ in range(3000):
        rank = draw.randint(0, 60000)
        if rank in held and draw.random() < 0.5:
            held.discard(rank)
            queue.remove(rank)
        else:
            held.add(rank)
            queue.add(rank)
        assert queue.first() == min(held, default=-1)


def test_ids_equal_the_library(encoding):
    texts = some_texts()
    ids, counts = bpe_queue.encode_texts(texts, RANKS)
    for text, own in zip(texts, np.split(ids, np.cumsum(counts)[:-1])):
        assert own.tolist() == encoding.encode_ordinary(text)


def test_encode_documents(spark, odd, encoding):
    rows = bpe_queue.encode_documents(odd, RANKS).collect()
    texts = [r.text or "" for r in odd.collect()]
    assert sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == sorted(
        (len(ids := np.array(encoding.encode_ordinary(t), "<u4")), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for t in texts)
    assert bpe_queue.encode_documents(odd.limit(0), RANKS).count() == 0


def test_variable_length_round_trip():
    values = np.array([0, 1, 255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1] * 333 + [7], np.uint32)
    for n in (0, 1, 2, 3, 4, 5, len(values)):
        assert (token_files.unpack(*token_files.pack(values[:n]), n) == values[:n]).all()


def test_library_pieces_equal_whole_texts():
    tokenizer = Tokenizer.from_file(JSON)
    texts = some_texts()
    ids, counts = token_files.library_ids(texts, JSON)
    for text, own in zip(texts, np.split(ids, np.cumsum(counts)[:-1])):
        assert own.tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_token_files(spark, odd, documents, tmp_path):
    tokenizer = Tokenizer.from_file(JSON)
    token_files.write_token_files(documents, JSON, f"{tmp_path}/a")
    got = {r.doc_id: r for r in token_files.read_token_files(spark, f"{tmp_path}/a").collect()}
    start = 0
    for row in documents.orderBy("doc_id").collect():
        ids = np.array([*tokenizer.encode(row.text or "", add_special_tokens=False).ids, 2], "<u4")
        assert (got[row.doc_id].start, got[row.doc_id].n_tokens, got[row.doc_id].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    token_files.write_token_files(odd, JSON, f"{tmp_path}/b")
    rows = token_files.read_token_files(spark, f"{tmp_path}/b").collect()
    assert len(rows) == odd.count() and min(rows, key=lambda r: r.start).doc_id is None
    token_files.write_token_files(odd.limit(0), JSON, f"{tmp_path}/c")
    assert token_files.read_token_files(spark, f"{tmp_path}/c").count() == 0
