import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from corpus_rows import SF_SMALL, edge, nothing  # noqa: F401
from pulsegrid.llm import pieces, registry, token_codes, transducer

MODEL = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BYTES)


def documents(spark):
    return spark.read.parquet(f"{SF_SMALL}/documents.parquet")


def mixed(library, n=1500):
    rng = random.Random(2)
    letters = "abcdefgh  éà▁日本😀\n\t\x00　 the ing 12="
    out = ["", " ", "a" * 3000, "=" * 70, " " * 40 + "a"] + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(n)]
    return out + ["".join(library.id_to_piece(rng.randrange(300, 32000)) for _ in range(30)) for _ in range(200)]


def test_agenda_matrix_and_heap_equal_the_library(library):
    table, p = pieces.memo(MODEL)
    for word in ("▁hello", "▁" * 20, "▁été日", "▁" + "ab" * 300):
        assert p.agenda(word) == library.encode(word[1:].replace("▁", " "))
    texts = mixed(library)
    chunks = pieces.chunks_of(pa.array(texts))
    entries = table.of(chunks)
    assert (table.per_text(chunks, entries) - np.diff(chunks.first)).tolist() == [len(library.encode(t)) for t in texts]


def test_transducer_counts_equal_the_library(library):
    texts = mixed(library)
    assert transducer.count_texts(transducer.compiled(MODEL), pa.array([*texts, None])).tolist() == [*(len(library.encode(t)) for t in texts), 0]


@pytest.mark.parametrize("letters", ["x", "ab", "etaoinshr", "éàß日", "01"])
def test_long_words_are_scanned_in_a_few_rounds(library, letters, monkeypatch):
    """Chunks without a word start are read at once, and again only from states that turn up; maps are composed by doubling."""
    rng = random.Random(len(letters))
    size = 1_000_000 if len(letters) < 3 else 60_000
    texts = ["".join(rng.choices(letters, k=n)) for n in (size, 511, 512, 513, 1025)] + ["a b " + "".join(rng.choices(letters, k=3000)) + " c"]
    rounds, real = [], transducer.Transducer._lanes

    def counted(self, *args):
        rounds.append(len(args[-1]))
        return real(self, *args)

    monkeypatch.setattr(transducer.Transducer, "_lanes", counted)
    got = transducer.count_texts(transducer.compiled(MODEL), pa.array(texts))
    assert got.tolist() == [len(library.encode(t)) for t in texts]
    assert len(rounds) <= 20 and max(rounds) >= size // transducer.CHUNK - 2


def test_transducer_starts_anew_when_full(library):
    texts = mixed(library, 200)
    small = transducer.Transducer(pieces.Pieces(MODEL), kept=500)
    for part in (texts[:150], texts[150:]):
        assert small.count(*_points(part)).tolist() == [len(library.encode(t)) for t in part]


def _points(texts):
    spaced = [(" " + t).replace(" ", "▁") if t else "" for t in texts]
    return np.frombuffer("".join(spaced).encode("utf-32-le"), dtype=np.uint32), np.concatenate([[0], np.cumsum([len(t) for t in spaced])])


def encoded(library, rows):
    sha = lambda b: hashlib.sha256(b).hexdigest()
    out = []
    for doc_id, text in rows:
        ids = library.encode(text or "")
        out.append((doc_id, len(ids), sha(",".join(map(str, ids)).encode()), sha(library.decode(ids).encode())))
    return sorted(out, key=str)


def test_op6_equals_the_library(spark, library, edge):
    rows = [tuple(r) for r in documents(spark).select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in registry.QUERIES["op6_sentencepiece"](spark, SF_SMALL).collect()), key=str) == encoded(library, rows)
    assert sorted((tuple(r) for r in pieces.encode_decode(edge, MODEL).collect()), key=str) == encoded(library, [tuple(r) for r in edge.select("doc_id", "text").collect()])


def test_op4_equals_the_library(spark, library, edge):
    def want(rows):
        return sorted(((i, len((t or "").encode()), n := len(library.encode(t or "")), n > 4096) for i, t in rows), key=str)

    rows = [tuple(r) for r in documents(spark).select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in registry.QUERIES["op4_token_counts"](spark, SF_SMALL).collect()), key=str) == want(rows)
    assert sorted((tuple(r) for r in transducer.token_counts(edge, MODEL).collect()), key=str) == want([tuple(r) for r in edge.select("doc_id", "text").collect()])


def in_file(tokenizer, rows):
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_op8_equals_the_library(spark, tokenizer, edge):
    for docs, found in ((documents(spark), registry.QUERIES["op8_token_codes"](spark, SF_SMALL)), (edge, token_codes.token_file(edge, BYTES))):
        rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        assert sorted((tuple(r) for r in found.collect()), key=lambda r: r[1]) == in_file(tokenizer, rows)


def test_a_small_segment_holds_whole_documents(spark, tmp_path, tokenizer):
    rows = [(i, "some words here " * (i % 7)) for i in range(60)]
    path = str(tmp_path / "codes")
    token_codes.write_codes(spark.createDataFrame(rows, "doc_id long, text string"), path, BYTES, segment_tokens=40)
    segments = spark.read.parquet(path)
    assert segments.count() > 10
    assert sorted((tuple(r) for r in token_codes.read_codes(segments).collect()), key=lambda r: r[1]) == in_file(tokenizer, rows)


@pytest.mark.parametrize("ids", [[], [0], [255, 256, 70_000, 2**31, 5] * 500, list(range(2000))])
def test_codes_address_every_id(ids):
    codes = token_codes.Codes.from_bytes(token_codes.Codes.of(np.array(ids, dtype=np.uint32)).to_bytes())
    assert codes.all().tolist() == ids and [codes.at(i) for i in range(len(ids))] == ids
    with pytest.raises(IndexError):
        codes.at(len(ids))


def test_nothing(nothing):
    assert pieces.encode_decode(nothing, MODEL).count() == transducer.token_counts(nothing, MODEL).count() == token_codes.token_file(nothing, BYTES).count() == 0
