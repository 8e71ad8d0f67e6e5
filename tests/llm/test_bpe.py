import os
import random

import pytest

from quillmere.llm import bpe

pytestmark = pytest.mark.skipif(not os.path.exists(bpe.DEFAULT_VOCABULARY), reason="no vocabulary")
TEXTS = [
    None, "", " ", "a", "\n\n", "   x   y  ", "don't we'll they've I'M", "日本語のテキスト", "é́ ﬁ ½ ² 𝔘𝔫 🙂‍↔️", "\x00\x1c\x85 x", "a" * 3000, "ab" * 2000, "=" * 500 + " " * 700, "<|endoftext|> x", "tab\tand\r\nlines", "1234567 00042 3.14",
    "�� broken", "ünïcödé" * 50,
]


@pytest.fixture(scope="module")
def machine():
    return bpe.machine(bpe.load_vocabulary())


def test_equals_merges(machine):
    rng = random.Random(1)
    for _ in range(400):
        word = "".join(rng.choice("abcdetinghousr éß日x=-") for _ in range(rng.randrange(1, 30)))
        assert list(machine.word(word)) == machine.merge(word.encode())


def test_equals_library(machine):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    library.encode_special_tokens = True
    for text in TEXTS:
        assert list(machine.encode(text)) == library.encode(text or "", add_special_tokens=False).ids
        assert machine.count(text) == len(list(machine.encode(text)))


def test_round_trip_and_streaming(machine):
    for text in TEXTS:
        ids = list(machine.encode(text))
        assert machine.decode(ids) == (text or "")
        data = (text or "").encode()
        assert "".join(bpe.decode_stream(data[i : i + 1] for i in range(len(data)))) == (text or "")


def test_invalid_bytes_decode_as_the_library_does():
    for data in (b"\xff", b"\xc3", b"a\xe2\x82", b"\xf0\x9f\x98x", b"\xed\xa0\x80", b"\xc0\xaf", b"\xf4\x90\x80\x80"):
        assert "".join(bpe.decode_stream([data])) == data.decode("utf-8", "replace")


def test_output_lags_by_a_bounded_number_of_bytes(machine):
    fed = 0

    def feed():
        nonlocal fed
        for byte in b"internationalization" * 40:
            fed += 1
            yield byte

    emitted = 0
    for token in machine.steps(feed()):
        emitted += len(machine.bytes_of[token])
        assert fed - emitted <= 128


def test_columns(spark, machine):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)] + [(None, "x", 1), (1, "", 2)], "doc_id long, text string, ids int")
    rows = bpe.encode_column(df)
    assert rows.columns == ["doc_id", "ids"]
    got = rows.collect()
    assert len(got) == len(TEXTS) + 2
    by = {r.doc_id: r.ids for r in got}
    assert by[0] == by[1] == [] and by[3] == list(machine.encode("a")) and by[None] == list(machine.encode("x"))
    back = {r.doc_id: r.text for r in bpe.decode_column(rows).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(TEXTS))
    assert {r.doc_id: r.n_tokens for r in bpe.count_column(df).collect()}[3] == 1
    assert bpe.encode_column(df.limit(0)).collect() == []
