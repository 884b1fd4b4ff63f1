import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from rasterflow.llm import bpe, token_counts, token_files
from rasterflow.llm.common import fresh_dir

WORD, BYTE = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json")


def odd_texts(n=400):
    random.seed(1)
    letters = list("ab'srevl dm t  \n\t.!1²éÉ<|>漢İ́")
    return ["", " ", "it's we're they'll I'm he'd x've 's '' 's\n's it''s 'rex", "a  b\n\n c \t d  ", "<|endoftext|>hi<|endoftext|>", "a\r\nb"] + ["".join(random.choice(letters) for _ in range(random.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_ids_are_the_librarys(path):
    texts, library = odd_texts(), Tokenizer.from_file(path)
    ids, n = (token_files.Encoder(path) if path == WORD else bpe.Codec(path)).encode(texts)
    want = [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    assert n.tolist() == [len(x) for x in want]
    assert ids.tolist() == [i for x in want for i in x]


def test_decoding_joins_strings_as_the_library_does():
    library, own = Tokenizer.from_file(BYTE), bpe.Codec(BYTE)
    random.seed(2)
    for _ in range(100):
        ids = [random.randrange(50257) for _ in range(random.randint(0, 9))]
        assert own.decode_text(np.array(ids, np.int64)) == library.decode(ids, skip_special_tokens=False)


def test_long_texts_are_cut_only_where_no_pretoken_spans(monkeypatch):
    from rasterflow.llm import pretokens

    text = "some words  and\nlines  " * 200
    parts = pretokens.cut(text, 100)
    assert "".join(parts) == text and len(parts) > 10
    monkeypatch.setattr(pretokens, "BLOCK_CHARS", 100)
    ids, _ = bpe.Codec(BYTE).encode([text])
    assert ids.tolist() == Tokenizer.from_file(BYTE).encode(text, add_special_tokens=False).ids


def test_files_hold_all_documents_in_id_order(spark, odd_docs, odd_rows):
    found = token_files.read_tokens(token_files.write_tokens(odd_docs, fresh_dir(spark, "t"), WORD)).collect()
    library = Tokenizer.from_file(WORD)
    want, start = [], 0
    for i, t, _ in sorted(odd_rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted((tuple(r) for r in found), key=lambda r: r[1]) == want


def test_counts(odd_docs, odd_rows):
    found = sorted((tuple(r) for r in token_counts.count_tokens(odd_docs, WORD, limit=50).collect()), key=str)
    library = Tokenizer.from_file(WORD)
    n = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    assert found == sorted(((i, len((t or "").encode()), n(t), n(t) > 50) for i, t, _ in odd_rows), key=str)


def test_digests(odd_docs, odd_rows):
    found = sorted((tuple(r) for r in bpe.encode_digests(odd_docs, BYTE).collect()), key=str)
    library, want = Tokenizer.from_file(BYTE), []
    for i, t, _ in odd_rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert found == sorted(want, key=str)
    texts = {r.decoded for r in bpe.encode_decode(odd_docs, BYTE).collect()}
    assert texts == {t or "" for _, t, _ in odd_rows}


def test_empty_tables(spark, no_docs):
    assert token_files.read_tokens(token_files.write_tokens(no_docs, fresh_dir(spark, "t"), WORD)).count() == 0
    assert token_counts.count_tokens(no_docs, WORD).count() == 0
    assert bpe.encode_digests(no_docs, BYTE).count() == 0
